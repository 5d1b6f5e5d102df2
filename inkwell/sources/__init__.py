"""inkwell.sources"""
