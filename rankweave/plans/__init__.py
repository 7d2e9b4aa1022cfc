"""Back-test plans composed of operators."""
