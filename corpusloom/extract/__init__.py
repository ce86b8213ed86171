"""Facts from source text: a Java parser, and the rules that turn what it finds into rows."""
