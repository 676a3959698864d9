"""crosstide: a PySpark engine for daily cross-sectional research panels.

load_spec reads a file of nodes, run computes them on a store, simulate turns
weights into a ledger and measure into metrics.
"""

from crosstide.operators.ledger import SimError, SimResult, simulate
from crosstide.operators.spec import SpecError
from crosstide.plans.config import Spec, load_spec
from crosstide.plans.evaluate import evaluate, measure
from crosstide.plans.naming import Ref, parse_ref
from crosstide.plans.node import run
from crosstide.sources.axes import Axes
from crosstide.sources.panels import MemoryPanels, Panels, Store, StoreError

__version__ = "0.1.0"
__all__ = ["Axes", "MemoryPanels", "Panels", "Ref", "SimError", "SimResult", "Spec", "SpecError", "Store", "StoreError", "evaluate", "load_spec", "measure", "parse_ref", "run", "simulate"]
