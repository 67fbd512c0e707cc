import sys

from .plans.commands import main

main(sys.argv[1:])
