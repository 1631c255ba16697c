"""DataFrame operators: statistics, aggregations, joins, linear algebra, clustering, splits and models."""
