"""loomgram: pan-k-mer analytics as lazy Spark DataFrame operators."""
