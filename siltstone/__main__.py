"""python -m siltstone CONFIG.toml: runs the daemon."""

import sys

from .streaming.server import main

if __name__ == "__main__":
    if len(sys.argv) != 2:
        sys.exit(__doc__)
    main(sys.argv[1])
