"""Analytics over accelerator profiling captures, as Spark DataFrame plans."""
