"""Where matrices, vectors and measurements come from and go to."""
