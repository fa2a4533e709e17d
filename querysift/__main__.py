"""python -m querysift: see commands."""

import sys

from .commands import main

sys.exit(main())
