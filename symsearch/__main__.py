from symsearch.cli import main

raise SystemExit(main())
