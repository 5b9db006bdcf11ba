"""``python -m auger train|score|outliers …`` (see ``auger.cli``)."""

import sys

from auger.cli import main

sys.exit(main())
