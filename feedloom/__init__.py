"""feedloom: community-feedback analytics as lazy Spark DataFrame transformations."""
