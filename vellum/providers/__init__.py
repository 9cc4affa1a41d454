"""Engines outside Spark: OCR, language models and thumbnails. Each is an object that goes to the executors."""
