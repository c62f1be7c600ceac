"""Tidemark: metrics over products and intervals as Spark plans."""

from tidemark.functions.catalog import ALIASES, CATALOG, resolve
from tidemark.plans.compiler import evaluate
from tidemark.plans.expr import ExpressionError, parse
from tidemark.plans.frame import IntervalFrame, observations, sliced
from tidemark.plans.scopes import block_apply, segment_apply

__all__ = ["ALIASES", "CATALOG", "ExpressionError", "IntervalFrame", "block_apply", "evaluate", "observations", "parse", "resolve", "segment_apply", "sliced"]
