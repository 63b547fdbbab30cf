"""Parameters of the registered queries for the test warehouse (30 days of events)."""
from __future__ import annotations

from datetime import date

START, END = "20240101", "20240130"
# Last two full weeks of the data, and the two halves of it.
THIS_WEEK = ("20240124", "20240130")
LAST_WEEK = ("20240117", "20240123")
HALF_A = ("20240101", "20240115")
HALF_B = ("20240116", "20240130")
AS_OF = date(2024, 1, 31)
FUNNEL_STEPS = ["signup", "view", "click", "purchase"]
WINDOW_DAYS = 7
