"""Tests of the operators for training data; a package, as file names here repeat those above."""
