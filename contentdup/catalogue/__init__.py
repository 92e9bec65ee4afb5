from contentdup.catalogue.oracles import ORACLES
from contentdup.catalogue.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
