"""Arguments of the registered queries."""

from datetime import date
from decimal import Decimal

SUMMARY = (date(2000, 1, 1), date(2000, 6, 30))
TREND_DAYS = (date(2000, 1, 15), date(2000, 4, 10))
TREND_MONTHS = (date(1998, 2, 1), date(2000, 12, 31))
PRODUCTS = (date(2000, 3, 1), date(2000, 5, 31))
ACTIVE = (date(2000, 10, 1), date(2000, 12, 31))
NOTES = (date(1996, 1, 5), date(1996, 1, 20))
AS_OF = date(2001, 7, 31)
REPORT_END = date(1996, 10, 1)
TREND_END_MONTH, TREND_LENGTH = date(1996, 12, 1), 24
COHORT_END_MONTH, COHORTS, PERIODS = date(1996, 6, 1), 12, 6
CHANNEL_REF = date(1995, 12, 1)
TOP_N = 20
K = Decimal("0.68")
SALT = "demo-salt"
PERTURB_SALT = "perturb-salt"
QTY_SALT = "qty-salt"
BRAND = "facebook|license"
SPLIT_DAY = date(1996, 1, 20)
REFETCH_DAYS = 3
