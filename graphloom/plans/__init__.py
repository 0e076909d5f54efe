"""The two query languages: text to tree to DataFrame, over a catalogue."""
