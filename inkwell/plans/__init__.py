"""inkwell.plans"""
