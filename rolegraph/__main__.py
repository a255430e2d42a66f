import sys

from rolegraph.cli import main

sys.exit(main())
