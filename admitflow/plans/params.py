"""Parameters shared by the registered limiter queries and their oracles."""

from ..sources.views import DAY_US

# The registered limiter queries admit 2 requests per key per day.
LIMIT = 2
WINDOW_US = DAY_US
