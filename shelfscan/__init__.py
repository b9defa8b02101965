"""shelfscan: file-inventory and document-collection analytics on Spark."""
