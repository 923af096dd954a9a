"""Document-corpus analytics on Spark: collection, identity, versioning, labelling and reporting as DataFrame plans."""

__version__ = "0.1.0"
