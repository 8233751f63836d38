"""Automated business analytics as Spark jobs: profile, clean, measure, explain, ask."""

from tallyforge.operators.clean import clean_dataset, clean_for_download
from tallyforge.operators.forecast import forecast
from tallyforge.operators.normalize import normalize
from tallyforge.operators.report import report
from tallyforge.plans.analysis import run_analysis
from tallyforge.plans.ask import ask, ask_many
from tallyforge.sources.readers import read_dataset, read_table
from tallyforge.sources.writers import persist_sections

__all__ = [
    "ask", "ask_many", "clean_dataset", "clean_for_download", "forecast", "normalize", "persist_sections",
    "read_dataset", "read_table", "report", "run_analysis",
]
