"""lectern: preparing, rewriting and evaluating short text on Spark."""
