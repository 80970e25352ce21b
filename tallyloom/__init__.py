"""Basket and catalogue analytics expressed as Spark DataFrame plans."""
