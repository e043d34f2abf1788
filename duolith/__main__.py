import sys

from .plans.tasks import main

main(sys.argv[1:])
