import sys

from weftmark.plans.runner import main

sys.exit(main(sys.argv[1:]))
