from veristrata.cli import main

raise SystemExit(main())
