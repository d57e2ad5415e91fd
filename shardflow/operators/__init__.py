"""What datasets do: exchange, ordering, aggregation, joins."""
