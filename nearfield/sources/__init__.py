"""Where data comes from and goes to: tables, embedding tables, result files."""
