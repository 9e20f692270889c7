"""DataFrame building blocks shared by the score plans."""
