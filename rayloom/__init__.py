"""rayloom: analytics for radiographic studies, and for training corpora, on Spark."""
