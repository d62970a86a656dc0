from glyphmill.cli import main

main()
