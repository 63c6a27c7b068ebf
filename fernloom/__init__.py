"""Spark-native analytics for collections of postings, people, companies and places."""
