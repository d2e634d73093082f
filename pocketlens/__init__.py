"""pocketlens: price-to-margin waterfall analytics on Spark."""
