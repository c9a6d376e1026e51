import sys

from quarry.plans.shell import main

sys.exit(main())
