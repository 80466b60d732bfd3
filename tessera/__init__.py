"""Spark-native analytics engine for zone-risk feeds, crosswalks, geometry and tile pyramids."""
