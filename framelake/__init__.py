"""framelake: camera-stream and corpus analytics on PySpark DataFrames."""
