"""weirgate: session-aware content inspection as Spark DataFrame transformations."""
