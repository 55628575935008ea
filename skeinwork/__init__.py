"""Text mining, link analysis, clustering and recommendation as Spark DataFrame operators."""
