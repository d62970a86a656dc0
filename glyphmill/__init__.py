"""Unicode, locale and text-corpus analytics as Spark DataFrame operators."""
