"""Analytics over the working memory of coding agents, written for Spark."""
