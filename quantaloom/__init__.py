"""quantaloom: tensor-format analytics and corpus preparation on PySpark."""
