"""Named, parameterless query plans built from the operators."""
