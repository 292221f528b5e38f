"""siftwell: extraction, validation and serving of facts from collected company pages, on Spark."""
