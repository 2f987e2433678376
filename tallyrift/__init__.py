"""Distribution rules on Spark: itemsets whose numeric target is distributed
differently inside the itemset than in the rest of the population."""

from tallyrift.plans.discovery import discover_rules, split_population
from tallyrift.session import build_session, materialize

__all__ = ["build_session", "discover_rules", "materialize", "split_population"]
