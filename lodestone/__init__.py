"""Lodestone: a Spark-native engine that mines, cleans and consolidates measurements from documents."""
