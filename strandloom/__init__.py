"""Spark-native genotype conversion, and operators for training-data pipelines."""

def __getattr__(name: str):
    """Config, convert_file and variants, loaded when they are asked for."""
    if name in ("Config", "convert_file", "variants"):
        from strandloom.plans import engine

        return getattr(engine, name)
    raise AttributeError(name)
