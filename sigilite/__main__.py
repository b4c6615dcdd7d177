"""``python -m sigilite``."""

import sys

from sigilite.cli import main

sys.exit(main())
