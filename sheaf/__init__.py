"""sheaf: point-in-time panels, walk-forward evaluation and text preparation on Spark."""
