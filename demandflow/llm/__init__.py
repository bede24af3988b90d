"""Operators for preparing training text at scale: one module per operator.

Nothing else in the library imports this package.  Each operator module keeps
the general interface (documents in, documents or facts out); the registered
``opN_<name>`` queries at the bottom of each module are thin wrappers that
derive the digest columns from the operator's output.
"""

from importlib import import_module

MODULES = ["quality", "linededup", "minhash", "decontaminate", "pieces", "langid", "licences", "lm", "substrings", "pii", "variants", "alignment", "gam"]

QUERIES: dict = {}
ORACLE: dict = {}


def load() -> None:
    """Import every operator module and gather its queries and SQL."""
    for m in MODULES:
        mod = import_module(f"{__name__}.{m}")
        QUERIES.update(mod.QUERIES)
        ORACLE.update(mod.ORACLE)
