"""Multi-site statistical genetics, fine-mapping and result analytics as Spark DataFrame operators."""
