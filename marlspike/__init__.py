"""Marlspike: an order-aware analytics engine on Spark SQL."""
