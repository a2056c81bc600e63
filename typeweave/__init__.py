"""typeweave: typed property graphs and training-data operators on PySpark."""

from typeweave.api import Constant, Edge, Element, Graph, Node, Query, Term, Type

__all__ = ["Constant", "Edge", "Element", "Graph", "Node", "Query", "Term", "Type"]
