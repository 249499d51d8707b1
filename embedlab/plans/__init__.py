"""Reports a user asks for, composed from the operators."""
