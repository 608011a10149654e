"""Multi-stage DataFrame plans shared by the operators."""
