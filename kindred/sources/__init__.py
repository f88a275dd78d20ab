"""Tables that the registered queries run on."""
