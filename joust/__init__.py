"""Tournament analytics over pairwise choices, as DataFrame plans."""
