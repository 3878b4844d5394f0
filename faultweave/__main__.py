import sys

from faultweave.plans.bucketing import main

sys.exit(main())
