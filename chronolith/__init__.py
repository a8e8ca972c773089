"""Repository-evolution analytics as Spark DataFrame transformations over one commit fact."""
