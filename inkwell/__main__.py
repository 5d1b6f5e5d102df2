import sys

from inkwell.cli import main

sys.exit(main())
