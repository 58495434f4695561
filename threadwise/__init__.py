"""Comment analytics and moderation as Spark DataFrame operators."""
