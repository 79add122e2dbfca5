"""Training-data operators of the language-model kind; nothing outside this package imports them."""
