"""navspark: fund and portfolio analytics as declarative Spark plans."""
