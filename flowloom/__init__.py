"""flowloom: analytics over estates of CI workflow definitions, written for Spark."""
