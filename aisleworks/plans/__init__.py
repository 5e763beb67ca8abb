"""Queries bound to the fixture tables. Importing this package registers all of them."""

from importlib import import_module
from pathlib import Path

for _module in sorted(Path(__file__).parent.glob("bound_*.py")):
    import_module(f"{__name__}.{_module.stem}")
