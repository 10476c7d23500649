"""lotscope: Spark jobs that turn marketplace lot logs into history, prices, matches, decisions and grades."""
