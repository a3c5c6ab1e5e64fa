"""Operations analytics as Spark DataFrame jobs."""
