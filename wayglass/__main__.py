import sys

from wayglass.commands import main

sys.exit(main(sys.argv[1:]))
