"""Connected components, as the corpus operators use them: the library's alternating star steps."""

from vectorloom.operators.graph import components, least_of, local_stars

__all__ = ["components", "least_of", "local_stars"]
