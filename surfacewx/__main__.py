import sys

from surfacewx.plans.cli import main

sys.exit(main())
