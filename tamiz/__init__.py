"""tamiz: text-moderation analytics and training-data preparation as Spark DataFrame pipelines."""
