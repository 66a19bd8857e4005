"""Analytics over short user comments, as Spark DataFrame transformations."""
