"""Report documents: SARIF, JSON, Markdown and HTML."""
