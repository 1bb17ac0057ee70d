"""parlance: conversation-library analytics on PySpark DataFrames."""
