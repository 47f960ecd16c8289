"""Recursive (Datalog-style) analytics expressed as Spark DataFrame plans."""

from deltaloop.plans.fixpoint import IterationStats, Result, run_program
from deltaloop.plans.model import Atom, Compare, Const, Decl, Expr, Program, Rule, Var, Wildcard
from deltaloop.plans.parser import parse_program

__all__ = [
    "Atom", "Compare", "Const", "Decl", "Expr", "IterationStats", "Program", "Result", "Rule",
    "Var", "Wildcard", "parse_program", "run_program",
]
