"""Models and chains."""
