"""Atalaya: procurement-risk analytics as Spark DataFrame operators."""
