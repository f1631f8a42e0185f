from provenix.commands import main

raise SystemExit(main())
